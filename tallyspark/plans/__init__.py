"""Registered queries and their SQL, one module an area."""

from tallyspark.plans import cards, checks, lists, months, recurring, reports, rules, scalars, staging, statements

MODULES = [months, recurring, checks, scalars, cards, rules, statements, staging, lists, reports]
