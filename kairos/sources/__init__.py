from .tables import load, load_tables  # noqa: F401
from . import storage  # noqa: F401
