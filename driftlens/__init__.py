"""Spark-native evaluation of predictors under shift, and training-data operators."""
