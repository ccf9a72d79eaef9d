"""viewmill: Spark-native operators for view-coverage analytics and dataset curation."""
