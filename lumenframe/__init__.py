"""A media-catalogue analytics engine written as lazy Spark DataFrame plans."""
