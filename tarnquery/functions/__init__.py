"""Part of tarnquery."""
