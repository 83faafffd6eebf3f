"""Spark-native transaction intelligence: features, rules, leads, graphs and queries over transfer ledgers."""
