"""riverspark.sources"""
