"""A PySpark-native engine for building, querying and scoring document and table question-answering corpora."""
