"""Whole plans: mining, evaluation, configuration."""
