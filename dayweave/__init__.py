"""Longitudinal behaviour analytics and corpus processing as Spark jobs."""
