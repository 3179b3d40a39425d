"""Scratch tables, for the operators of this subpackage."""

from ..scratch import drop, keep, shared_folder

__all__ = ["drop", "keep", "shared_folder"]
