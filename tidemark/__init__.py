"""Tidemark: coding-agent activity analytics and corpus preparation as Spark plans."""
