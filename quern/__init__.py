"""quern: a relational and text analytics engine on PySpark."""

from quern.session import session

__all__ = ["session"]
