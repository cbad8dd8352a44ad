"""Errors, metadata, hints and modes."""

from __future__ import annotations

import contextlib
import threading
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from enum import Enum

from ..functions.scalars import DType

SUCCESS, INPUT_ERROR, EXECUTION_FAILURE = 0, 1, 2


class SparseError(Exception):
    """status (1 input, 2 execution), the position of the argument at fault, and what is wrong."""

    status = INPUT_ERROR

    def __init__(self, message: str, arg_pos: int = 0):
        super().__init__(message)
        self.arg_pos, self.message = arg_pos, message

    def __str__(self) -> str:
        where = f" (argument {self.arg_pos})" if self.arg_pos else ""
        return f"{type(self).__name__}{where}: {self.message}"


class InputParameterError(SparseError):
    status = INPUT_ERROR


class ExecutionFailure(SparseError):
    status = EXECUTION_FAILURE


class Trans(Enum):
    """op(A): A, its transpose, or its conjugate transpose."""

    N = 300
    T = 310
    C = 320

    @classmethod
    def of(cls, x: Trans | str | int, arg_pos: int = 0) -> Trans:
        try:
            return x if isinstance(x, cls) else cls[x] if isinstance(x, str) else cls(x)
        except (KeyError, ValueError):
            raise InputParameterError(f"unknown transpose {x!r}: N, T or C", arg_pos) from None


class Shape(Enum):
    RECTANGULAR = "rectangular"
    LOWER = "lower"
    UPPER = "upper"


class Diag(Enum):
    UNIT = "unit"
    NON_UNIT = "non_unit"
    ZERO = "zero"


#: Hint types with the values each takes.
HINTS: dict[str, tuple] = {
    "structure": ("unstructured", "symmetric", "diagonal", "block_diagonal", "banded", "triangular", "block_triangular", "hermitian", "symmetric_pattern", "unset"),
    "memory": ("no_alloc", "alloc"),
    "spmv_operation": tuple(Trans),
    "spmm_operation": tuple(Trans),
    "spadd_operation": tuple(Trans),
    "spsv_operation": tuple(Trans),
    "spsm_operation": tuple(Trans),
    "spelmm_operation": tuple(Trans),
    "sddmm_operation": tuple(Trans),
    "spmv_invocations": ("single", "few", "many"),
    "spmm_invocations": ("single", "few", "many"),
    "spadd_invocations": ("single", "few", "many"),
    "spsv_invocations": ("single", "few", "many"),
    "spelmm_invocations": ("single", "few", "many"),
    "sddmm_invocations": ("single", "few", "many"),
    "spmm_strategy": ("unset", "join", "broadcast"),
    "sddmm_strategy": ("unset", "join", "arrays"),
    "spsv_strategy": ("unset", "fold", "levels", "blocks"),
}


@dataclass(frozen=True)
class Hints:
    """What the caller expects to do; validated, never needed for right results."""

    values: tuple[tuple[str, object], ...] = ()

    def get(self, name: str, default=None):
        return dict(self.values).get(name, default)

    def with_(self, name: str, value) -> Hints:
        if name not in HINTS:
            raise InputParameterError(f"unknown hint {name!r}", 2)
        if name.endswith("_operation"):
            value = Trans.of(value, 3)
        if value not in HINTS[name]:
            raise InputParameterError(f"hint {name} takes one of {HINTS[name]}, not {value!r}", 3)
        return Hints(tuple({**dict(self.values), name: value}.items()))


@dataclass(frozen=True)
class MatrixMeta:
    """m rows, n columns; kind is "general", "null" (no entries) or "identity"; index_base is how indices are shown; block_size is that of block export."""

    m: int
    n: int
    dtype: DType
    kind: str = "general"
    index_base: int = 0
    layout: str = "coo"
    no_copy: bool = False
    block_size: int = 1
    hints: Hints = field(default_factory=Hints)

    @property
    def typeless(self) -> bool:
        return self.kind in ("null", "identity")

    def with_(self, **changes) -> MatrixMeta:
        return replace(self, **changes)


def check_shape(m: int, n: int) -> None:
    if m < 0:
        raise InputParameterError("a negative number of rows", 2)
    if n < 0:
        raise InputParameterError("a negative number of columns", 3)


def check_base(base: int, arg_pos: int = 4) -> None:
    if base not in (0, 1):
        raise InputParameterError("an index base is 0 or 1", arg_pos)


# --- reproducibility --------------------------------------------------------------------

_MODES = ("default", "reproducible")
_mode = threading.local()


def get_reproducibility() -> str:
    return getattr(_mode, "value", "default")


def set_reproducibility(mode: str) -> None:
    """In the mode "reproducible" sums are taken in a fixed order, however the data is partitioned."""
    if mode not in _MODES:
        raise InputParameterError(f"unknown reproducibility mode {mode!r}", 1)
    _mode.value = mode


@contextlib.contextmanager
def reproducible() -> Iterator[None]:
    before = get_reproducibility()
    set_reproducibility("reproducible")
    try:
        yield
    finally:
        set_reproducibility(before)
