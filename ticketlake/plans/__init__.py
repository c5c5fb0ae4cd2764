"""Session setup and multi-step jobs (layered build with data-test gates)."""
