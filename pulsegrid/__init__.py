"""Metric analytics on Spark: cleaning, anomaly detection, forecasting, alerting.

Every public function takes DataFrames and returns DataFrames, so steps chain
with ``df.transform(...)`` and Catalyst plans the whole job at once.
"""
