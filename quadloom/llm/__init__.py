"""Text operators for preparing large training corpora (self-contained subpackage)."""
