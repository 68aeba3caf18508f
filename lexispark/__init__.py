"""lexispark: language-model corpus preparation and evaluation as Spark DataFrame plans."""
