"""Part of spanmill; see the README."""
