"""What can go wrong, by kind."""

from __future__ import annotations

from enum import Enum


class Kind(Enum):
    """Kinds of error and what they say."""

    ERROR_OCCURED = "processing failed"
    WRONG_FILE_FORMAT = "the file is not of the expected format"
    FILE_NOT_EXIST = "the file does not exist"
    PERMISSION_DENIED = "access to the file is denied"
    UNEXPECTED_FILE_ERROR = "the file can't be used"
    FILE_READ_ERROR = "the file ends early or can't be read"
    FILE_WRITE_ERROR = "the file can't be written"
    EMPTY_POINT_CLOUD = "the cloud has no points"
    EMPTY_RESULT = "there is no result yet"
    EMPTY_PARAMS = "a required parameter is missing"
    INVALID_PARAM_SEGMENT = "a segmentation parameter is out of range"
    INITIALIZER_ERROR = "used before it was set up"
    BAD_PARAMETERS = "a parameter has no valid value"
    UNMATCHED_CLOUD_SIZE = "two clouds differ in size"
    BAD_TIME_STAMP = "the timestamp is not valid"
    OUT_OF_RANGE = "a position is out of range"
    BAD_POSITION = "an octant is not one of 0 to 7"
    EMPTY_OCTREE = "there is no octree to transform with"
    UNMATCHED_COLOR_SIZE = "there is not one colour for each point"
    ZSTD_ERROR = "zstandard failed"
    EMPTY_GOP = "the group of pictures is empty"
    BAD_SLICE = "the slice's type is not valid"
    EMPTY_REFERENCE = "a predicted slice has no intra slice before it"
    INVALID_DIR = "the directory is not valid"
    UNMATCHED_PATCH_SIZE = "adjacent frames differ in their number of patches"


class EngineError(Exception):
    def __init__(self, kind: Kind, detail: str = ""):
        self.kind = kind
        super().__init__(f"{kind.name}: {kind.value}" + (f" ({detail})" if detail else ""))
