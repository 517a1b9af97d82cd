"""DataFrame operators over a corpus."""
