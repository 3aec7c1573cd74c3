"""Analytics over event streams about people, requests, money and decisions, on Spark DataFrames."""
