"""End-to-end plans: warehouse layers and the wide table."""
