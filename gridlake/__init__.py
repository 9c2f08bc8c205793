"""gridlake: metered time series at cluster scale, declared on Spark DataFrames."""
