"""riverspark.streaming"""
