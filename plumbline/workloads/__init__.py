"""All registered queries."""

from plumbline.workloads import group_level, reply_level, result_level, row_level
from plumbline.workloads.registry import WORKLOADS

__all__ = ["WORKLOADS", "group_level", "reply_level", "result_level", "row_level"]
