"""Text of HTML and XML documents by native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Removed with what they hold, then tags, then white space; both engines read the expressions alike.
STEPS = ((r"(?is)<(script|style|head)[^>]*>.*?</(script|style|head)>", " "), (r"(?s)<!--.*?-->", " "), (r"(?s)<[^>]*>", " "))
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))
SPACE = r"[ \t\r\n\f]+"


def html_text(html: Column) -> Column:
    for pattern, put in STEPS:
        html = F.regexp_replace(html, pattern, put)
    for entity, char in ENTITIES:
        html = F.replace(html, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(html, SPACE, " "))


def oracle(html: str) -> str:
    for pattern, put in STEPS:
        html = f"regexp_replace({html}, '{pattern}', '{put}', 'g')"
    for entity, char in ENTITIES:
        html = "replace({}, '{}', '{}')".format(html, entity, char.replace("'", "''"))
    return f"trim(regexp_replace({html}, '{SPACE}', ' ', 'g'))"
