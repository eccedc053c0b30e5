"""Spark jobs that explain movements in business KPIs.

Every public function takes DataFrames keyed by (kpi, region, window_start) and
returns a DataFrame; no function loops over incidents on the driver.
"""
