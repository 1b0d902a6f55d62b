"""riverspark.plans"""
