"""riverspark.functions"""
