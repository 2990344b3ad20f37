"""Languages of messages, sessions and log lines."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import folded_tokens, has_ideograph, opaque, pieces

LEAST_TOKENS, SAMPLE = 5, 5

#: Function words (folded) that vote for a language; a word may vote for several.
VOTES = {
    "de": "aber als am auch auf aus bei das dem den der des die ein eine einem einen einer er es fur hat ich ihr im in ist ja kann mir mit nach nicht noch nur oder schon sein sich sie sind so und uber um uns von war was wenn wie wir zu zum zur",
    "en": "a about all an and are as at be been but by can do for from had has have he her his i if in is it its me my no not of on or our she so that the their them there they this to was we were what when which who will with would you your",
    "es": "al algo como con cuando de del donde el ella en era es esta este esto estoy fue hay la las le lo los mas me mi muy nada no nos o para pero por porque que se si sin sobre son su sus tambien te tengo tiene todo tu un una y ya yo",
    "fr": "a au aux avec c ce cela ces cette dans de des du elle en est et etait etre fait il ils j je l la le les leur lui ma mais me mes moi mon ne nous on ou par pas plus pour qu que qui s sa sans se ses son sont sur te tres tu un une vous y",
    "pt": "a ao aos as com como da das de do dos e ela ele em era essa esse esta este eu foi ha isso isto ja mais mas me meu minha muito na nao nas no nos o os ou para pela pelo por porque quando que se sem ser seu sua sao tambem te tem um uma voce",
}

SPANISH = "bien cojones coño de del dime el esta está esto gracias hay haz joder la las los mierda mira otra para perfecto por porque que quiero revisa vale".split() + ["otra vez"]
ENGLISH = "fix from good great issue please review thank thanks that the this with work".split()


def log_language(text: Column) -> Column:
    """es, en or unknown: hints between blanks, and Spanish letters, by strict majority."""
    padded = F.concat(F.lit(" "), F.lower(text), F.lit(" "))
    votes = lambda words: reduce(add, (padded.contains(f" {w} ").cast("int") for w in words))
    es, en = votes(SPANISH) + F.when(padded.rlike("[¡¿ñáéíóú]"), 2).otherwise(0), votes(ENGLISH)
    return F.when(es > en, "es").when(en > es, "en").otherwise("unknown")


def _known(norm: Column, words: list[str]) -> Column:
    return F.size(F.filter(norm, lambda t: t.isin(words)))


def recognized(text: Column, votes: dict[str, Column]) -> Column:
    """The language with the most function words, on ties the alphabetically first; ja, ko and zh by their scripts; null if nothing speaks for any."""
    best = F.array_max(F.array(*(F.struct(n.alias("n"), F.lit(-i).alias("i"), F.lit(lang).alias("lang")) for i, (lang, n) in enumerate(sorted(votes.items())))))
    return F.when(text.rlike(r"[\p{IsHiragana}\p{IsKatakana}]"), "ja").when(text.rlike(r"\p{IsHangul}"), "ko").when(has_ideograph(text), "zh").when(best["n"] > 0, best["lang"])


def message_language(text: Column, found: Column, n_tokens: Column) -> Column:
    """A message's language; null if it is undetermined. Ideographs decide at any length; else it takes five tokens (of the unsegmented text). found: what was recognized."""
    return F.when(has_ideograph(text) & (F.coalesce(found, F.lit("zh")) == "zh"), "zh").when(n_tokens >= LEAST_TOKENS, found)


def detect(df: DataFrame, text: str = "text", out: str = "lang") -> DataFrame:
    """df with a language column."""
    every = sorted({w for words in VOTES.values() for w in words.split()})
    # a column for each step: within one expression a step would be computed for every use
    rows = df.withColumn("__raw", opaque(pieces(F.col(text)))).withColumn("__norm", opaque(F.array_remove(folded_tokens(F.col("__raw")), "")))
    rows = rows.withColumn("__hits", opaque(F.filter("__norm", lambda t: t.isin(every))))
    found = recognized(F.col(text), {lang: _known(F.col("__hits"), words.split()) for lang, words in VOTES.items()})
    return rows.withColumn("__found", opaque(found)).withColumn(out, message_language(F.col(text), F.col("__found"), F.size("__norm"))).drop("__raw", "__norm", "__hits", "__found")


def session_samples(df: DataFrame, session: str, order: str, text: str) -> DataFrame:
    """(session, sample): the first five messages, one on a line."""
    first = Window.partitionBy(session).orderBy(order)
    rows = df.select(session, order, text).withColumn("__r", F.row_number().over(first)).where(F.col("__r") <= SAMPLE)  # the rank limit runs before the shuffle
    return rows.groupBy(session).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__r", F.coalesce(text, F.lit("")).alias("t")))), lambda x: x["t"]), "\n").alias("sample"))


def dominant(df: DataFrame, by: str, lang: str = "lang") -> DataFrame:
    """(by, lang, n): the most frequent language of each group, on ties the alphabetically first; groups without any don't appear."""
    n = df.where(F.col(lang).isNotNull()).groupBy(by, lang).agg(F.count("*").alias("n"))
    return n.groupBy(by).agg(F.min(F.struct((-F.col("n")).alias("m"), F.col(lang).alias("l"))).alias("x")).select(by, F.col("x.l").alias(lang), (-F.col("x.m")).alias("n"))
