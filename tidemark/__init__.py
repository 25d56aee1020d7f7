"""tidemark: analytics, table onboarding, corpus and event-feed operators for Spark DataFrames."""
