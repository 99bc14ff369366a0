"""Analytics on the operational data of a job platform, as functions from DataFrame to DataFrame."""
