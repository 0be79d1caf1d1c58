"""Readers and writers: fixture views, delimited intake, text tables, record stores."""
