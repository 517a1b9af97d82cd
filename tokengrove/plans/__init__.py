"""Building blocks that keep plans balanced: slices, salts, checkpoints, bounded text parts."""
