"""Operators put together: mining, learning and detection from end to end."""
