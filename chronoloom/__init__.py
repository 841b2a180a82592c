"""A PySpark engine for labelled time series: conversion, storage, matchers, queries."""

from chronoloom.operators.limits import Quota, ResourceExhausted, is_resource_exhausted
from chronoloom.operators.matchers import Matcher, eq, neq, nre, re
from chronoloom.plans.convert import ConvertOptions, convert
from chronoloom.plans.query import MatchCache, Querier, QueryOptions, SelectHints
from chronoloom.sources.storage import Store, open_store, write_store

__all__ = [
    "ConvertOptions",
    "MatchCache",
    "Matcher",
    "Querier",
    "QueryOptions",
    "Quota",
    "ResourceExhausted",
    "SelectHints",
    "Store",
    "convert",
    "eq",
    "is_resource_exhausted",
    "neq",
    "nre",
    "open_store",
    "re",
    "write_store",
]
