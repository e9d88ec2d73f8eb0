"""Registered queries over the driver's tables, each with an independent SQL check where one exists."""
