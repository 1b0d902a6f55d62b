"""riverspark.operators"""
