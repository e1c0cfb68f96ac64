"""Error codes of outcome columns."""

from enum import StrEnum

from pyspark.sql import Column
from pyspark.sql import functions as F


class Outcome(StrEnum):
    OK = "OK"
    DELETED = "DELETED"
    SESSION_NOT_FOUND = "SESSION_NOT_FOUND"
    MODEL_NOT_FOUND = "MODEL_NOT_FOUND"
    MAPPING_NOT_FOUND = "MAPPING_NOT_FOUND"
    PROVIDER_NOT_FOUND = "PROVIDER_NOT_FOUND"
    PROVIDER_INACTIVE = "PROVIDER_INACTIVE"
    PROVIDER_IN_USE = "PROVIDER_IN_USE"
    SCOPE_MISMATCH = "SCOPE_MISMATCH"
    TYPE_UNSUPPORTED = "TYPE_UNSUPPORTED"
    MEMORY_NOT_FOUND = "MEMORY_NOT_FOUND"
    DUPLICATE = "DUPLICATE"
    NOT_LOGIN = "NOT_LOGIN"
    NO_PERMISSION = "NO_PERMISSION"


#: The codes that clients see, in order; a code that is given twice stands for its first name.
CODES = {
    "SESSION_NOT_FOUND": 40001,
    "CONTEXT_LIMIT_EXCEEDED": 40002,
    "PROVIDER_NOT_FOUND": 40011,
    "PROVIDER_ALREADY_EXISTS": 40012,
    "PROVIDER_IN_USE": 40013,
    "PROVIDER_FORBIDDEN": 40014,
    "MODEL_NOT_FOUND": 40021,
    "MODEL_ALREADY_EXISTS": 40022,
    "MODEL_MAPPING_NOT_FOUND": 40023,
    "MODEL_MAPPING_ALREADY_EXISTS": 40024,
    "MODEL_SCOPE_MISMATCH": 40025,
    "MODEL_PROVIDER_TYPE_UNSUPPORTED": 40026,
    "LLM_GENERATION_FAILED": 50011,
    "MEMORY_NOT_FOUND": 40001,
    "MEMORY_OPERATION_FAILED": 50021,
    "NOT_LOGIN": 401,
    "UNAUTHORIZED": 401,
    "IDENTITY_UNAUTHORIZED": 403,
    "OPERATION_UNAUTHORIZED": 403,
    "RESOURCE_UNAUTHORIZED": 403,
}


def code_of(name: Column) -> Column:
    """The code of a name, or null."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in CODES.items() for x in pair]), name)


def name_of(code: Column) -> Column:
    """The first name with that code, or null."""
    first = {c: n for n, c in reversed(CODES.items())}
    return F.element_at(F.create_map(*[F.lit(x) for pair in first.items() for x in pair]), code.cast("int"))
