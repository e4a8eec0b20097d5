"""Error kinds with stable codes."""

from __future__ import annotations

#: Codes that callers may rely on.
KINDS = ("invalid_argument", "model", "io", "parse", "unsupported", "pos_unavailable", "runtime")


class WordloomError(Exception):
    """Base of the library's own errors; kind is one of KINDS."""

    kind = "runtime"


class InvalidArgument(WordloomError, ValueError):
    kind = "invalid_argument"


class ModelError(WordloomError, ValueError):
    """A model file that can't be read."""

    kind = "model"


class ReadError(WordloomError, OSError):
    """A file or download that can't be read."""

    kind = "io"


class ParseError(WordloomError, ValueError):
    """Corpus or feature text that can't be read."""

    kind = "parse"


class Unsupported(WordloomError, ValueError):
    kind = "unsupported"


class PosUnavailable(WordloomError, ValueError):
    """Tags were asked of a model that has no tag stage."""

    kind = "pos_unavailable"


class AlreadyTrained(WordloomError, RuntimeError):
    """A trainer trains once."""


def kind_of_error(e: BaseException) -> str:
    """The code of any exception that the API lets out."""
    if isinstance(e, WordloomError):
        return e.kind
    return "parse" if isinstance(e, UnicodeError) else "io" if isinstance(e, OSError) else "invalid_argument" if isinstance(e, (ValueError, TypeError)) else "runtime"
