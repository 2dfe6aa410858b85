"""Game-record analytics as functions from DataFrame to DataFrame."""
