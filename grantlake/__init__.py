"""grantlake: access-policy analytics and policy enforcement on Spark DataFrames."""
