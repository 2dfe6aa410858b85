"""Part of rookery; see the README."""
