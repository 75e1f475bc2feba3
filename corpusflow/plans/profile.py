"""Profiles: Python files that define a pipeline as FILTER, or a function that makes one as FACTORY."""

from __future__ import annotations

import importlib.util
import logging
import sys
from collections.abc import Callable
from os import PathLike
from pathlib import Path
from types import ModuleType

from corpusflow.plans.pipeline import Pipeline

logger = logging.getLogger(__name__)


def _module(path: str | PathLike) -> ModuleType:
    file = Path(path)
    if str(file.parent) not in sys.path:
        sys.path.append(str(file.parent))
    spec = importlib.util.spec_from_file_location(file.stem, file)
    if spec is None or spec.loader is None or not file.exists():
        raise FileNotFoundError(f"no such profile: {file}")
    found = importlib.util.module_from_spec(spec)
    sys.modules[file.stem] = found
    spec.loader.exec_module(found)
    return found


def load_filter_from_file(path: str | PathLike) -> Pipeline:
    found = getattr(_module(path), "FILTER", None)
    if found is None:
        raise NotImplementedError(f"{path} defines no FILTER")
    if not isinstance(found, Pipeline):
        raise TypeError("FILTER must be a Pipeline")
    return found


def load_factory_from_file(path: str | PathLike) -> Callable[..., Pipeline]:
    found = getattr(_module(path), "FACTORY", None)
    if found is None:
        raise NotImplementedError(f"{path} defines no FACTORY")
    return found


def load_parametrized_filter_from_file(path: str | PathLike, *args: str) -> Pipeline:
    return load_factory_from_file(path)(*args)


def load_profile(path: str | PathLike, *args: str) -> Pipeline:
    """FILTER if there is one (arguments are then ignored with a warning), else FACTORY(*args)."""
    try:
        found = load_filter_from_file(path)
    except NotImplementedError:
        return load_parametrized_filter_from_file(path, *args)
    if args:
        logger.warning("FILTER takes no arguments; %d ignored", len(args))
    return found
