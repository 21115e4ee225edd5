"""Query catalogue, derived graph views and storage of intermediate results."""
