"""The library's intermediate tables, under the name that the operators use."""

from ..scratch import CLEANUP, MADE, Scratch, release, shared_dir

__all__ = ["CLEANUP", "MADE", "Scratch", "release", "shared_dir"]
