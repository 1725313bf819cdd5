"""Part of docloom; see the README."""
