"""File events and event-time aggregates as streams."""
