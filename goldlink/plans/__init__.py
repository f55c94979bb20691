"""Planning helpers: scratch tables, policies, the end-to-end pipeline."""
