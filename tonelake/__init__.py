"""tonelake: message-tone analytics and corpus operators on plain PySpark DataFrames."""
