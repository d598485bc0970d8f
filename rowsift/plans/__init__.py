"""Logical plans that both query languages compile to."""
