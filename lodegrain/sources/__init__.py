"""Files, scrape logs, sessions, web pages and search results as DataFrames."""
