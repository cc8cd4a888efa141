"""Running projects: dialect, loading, deployment, listings, reports."""
