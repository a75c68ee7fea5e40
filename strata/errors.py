"""One exception for all failures of the versioned API, with a code that callers can test."""

from __future__ import annotations

from enum import Enum


class Code(Enum):
    INVALID_PARAMETER = "invalid parameter"
    INVALID_SCHEMA = "row does not fit the table's columns"
    INVALID_VALUE = "invalid value"
    KEY_EXISTS = "key exists"
    KEY_NOT_EXISTS = "key does not exist"
    VERSION_NOT_EXISTS = "version does not exist"
    REFERRING_VERSION_NOT_EXISTS = "parent version does not exist"
    INCONSISTENT_KEY = "version belongs to another key"
    BRANCH_EXISTS = "branch exists"
    BRANCH_NOT_EXISTS = "branch does not exist"
    COLUMN_NOT_EXISTS = "column does not exist"
    ROW_EXISTS = "row exists"
    ROW_NOT_EXISTS = "row does not exist"
    INDEX_OUT_OF_RANGE = "index out of range"
    MAP_KEY_EXISTS = "map key exists"
    MAP_KEY_NOT_EXISTS = "map key does not exist"
    ELEMENT_EXISTS = "element exists"
    NOT_EMPTY_TABLE = "table is not empty"
    EMPTY_TABLE = "table is empty"
    ENTRY_NOT_EXISTS = "data entry does not exist"
    ILLEGAL_ENTRY_NAME = "illegal attribute in a data entry name"
    SCHEMA_NOT_FOUND = "dataset schema not found"
    MERGE_CONFLICT = "merge conflict"
    INVALID_BASE32 = "invalid base32 string"
    QUERY_SYNTAX = "query can't be parsed"
    CHUNK_NOT_EXISTS = "chunk does not exist"
    TYPE_MISMATCH = "object is of another type"


class StrataError(Exception):
    def __init__(self, code: Code, detail: str = ""):
        super().__init__(f"{code.value}: {detail}" if detail else code.value)
        self.code = code
