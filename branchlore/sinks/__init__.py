"""JSON datasets, the dashboard document, tables and views."""
