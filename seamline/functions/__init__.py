"""Part of seamline."""
