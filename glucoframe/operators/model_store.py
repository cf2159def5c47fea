"""Models of a Python worker process, kept between the tasks that it runs.

Spark reuses Python workers, so what a module holds outlives a task. Models are told apart by an id
of their content that the caller gives; the least recently used one goes when there are more than
``MOST``.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable

MOST = 4
_models: OrderedDict[str, object] = OrderedDict()


def get(model_id: str, load: Callable[[], object], most: int = MOST) -> object:
    """The model of that id, loaded at its first use in this process."""
    if model_id in _models:
        _models.move_to_end(model_id)
        return _models[model_id]
    model = load()
    _models[model_id] = model
    while len(_models) > most:
        _models.popitem(last=False)
    return model
