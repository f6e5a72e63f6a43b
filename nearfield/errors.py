"""Error codes, their names, and the exceptions that carry them."""

from __future__ import annotations

# Codes and names of the public contract.
CODES: dict[str, int] = {
    "VV_OK": 0,
    "VV_ERR_IO": -1,
    "VV_ERR_NOMEM": -2,
    "VV_ERR_INVALID_ARG": -3,
    "VV_ERR_NOT_FOUND": -4,
    "VV_ERR_EXISTS": -5,
    "VV_ERR_CORRUPT": -6,
    "VV_ERR_WRONG_VERSION": -7,
    "VV_ERR_LOCKED": -8,
    "VV_ERR_FILTER_PARSE": -9,
    "VV_ERR_OUT_OF_RANGE": -10,
    "VV_ERR_INTERNAL": -99,
}
UNKNOWN = "VV_ERR_UNKNOWN"
_NAMES = {code: name for name, code in CODES.items()}


def error_string(code: int) -> str:
    """The name of a code; unknown codes have a name of their own."""
    return _NAMES.get(code, UNKNOWN)


class NearfieldError(Exception):
    """Base of all errors; ``code`` is the contract's number."""

    code = CODES["VV_ERR_INTERNAL"]

    def __init__(self, message: str = ""):
        super().__init__(f"{error_string(self.code)}: {message}" if message else error_string(self.code))


def _kind(name: str, code: str) -> type[NearfieldError]:
    return type(name, (NearfieldError,), {"code": CODES[code], "__doc__": f"Error {CODES[code]}."})


IOFailure = _kind("IOFailure", "VV_ERR_IO")
InvalidArgument = _kind("InvalidArgument", "VV_ERR_INVALID_ARG")
NotFound = _kind("NotFound", "VV_ERR_NOT_FOUND")
AlreadyExists = _kind("AlreadyExists", "VV_ERR_EXISTS")
Corrupt = _kind("Corrupt", "VV_ERR_CORRUPT")
WrongVersion = _kind("WrongVersion", "VV_ERR_WRONG_VERSION")
Locked = _kind("Locked", "VV_ERR_LOCKED")
FilterParseError = _kind("FilterParseError", "VV_ERR_FILTER_PARSE")
OutOfRange = _kind("OutOfRange", "VV_ERR_OUT_OF_RANGE")
