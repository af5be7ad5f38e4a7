"""Operators of a training-data pipeline over tables of texts. Nothing else in loomwork imports this subpackage."""
