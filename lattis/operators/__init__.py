"""The engine's operators as functions on DataFrames; each is a composition of built-in ones, for Catalyst to plan."""

from lattis.operators.aggregate import Aggregate, global_aggregate, group_by, group_order
from lattis.operators.join import cross_join, equi_join, hinted, semi_join, theta_join
from lattis.operators.modify import Change, delete_rows, duplicate_keys, update_rows
from lattis.operators.relational import compare, conjunction, filter_rows, limit, order_by, project, top_k
from lattis.operators.setops import union_distinct

__all__ = ["Aggregate", "Change", "compare", "conjunction", "cross_join", "delete_rows", "duplicate_keys", "equi_join", "filter_rows", "global_aggregate", "group_by", "group_order", "hinted", "limit", "order_by", "project", "semi_join", "theta_join", "top_k", "union_distinct", "update_rows"]
