"""loomtext: a Spark-native engine for long-form text, dialogue and the feeds around them."""
