"""Readers of projects: SQL files, CSV files, YAML sidecars."""
