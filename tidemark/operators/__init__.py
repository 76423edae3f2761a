"""Query operators over points."""
