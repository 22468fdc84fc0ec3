"""KPI analytics on PySpark: functions from DataFrame to DataFrame."""
