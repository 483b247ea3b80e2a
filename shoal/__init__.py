"""A Spark-native engine for searching and maintaining large catalogs of files and documents."""
