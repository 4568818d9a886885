"""Readers of master lists, label texts, recognised passes and images."""
