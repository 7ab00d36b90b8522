"""tallyrail: evaluation-record analytics on Spark DataFrames."""

from tallyrail.session import get_session

__all__ = ["get_session"]
