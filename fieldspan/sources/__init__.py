"""Readers: measurement files, archives, catalogues, spreadsheets, reports."""
