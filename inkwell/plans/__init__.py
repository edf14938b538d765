"""Composed plans and the registry of queries."""

from . import registry  # noqa: F401, E402  (first: it holds the tables of queries)
from . import passages  # noqa: F401, E402, I001
from . import answers  # noqa: F401, E402, I001
from . import search  # noqa: F401, E402, I001
from . import evidence  # noqa: F401, E402, I001
from . import records  # noqa: F401, E402, I001
from . import replies  # noqa: F401, E402, I001
from . import citations  # noqa: F401, E402, I001
from . import verdicts  # noqa: F401, E402, I001
from . import asking  # noqa: F401, E402, I001
from . import benchmarking  # noqa: F401, E402, I001
