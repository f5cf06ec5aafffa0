"""Point-cloud sequence analytics as DataFrame operations."""
