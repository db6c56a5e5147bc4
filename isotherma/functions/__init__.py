"""Column functions: geography, calendar, labels, numbers."""

from .geo import *  # noqa: F401,F403
from .labels import *  # noqa: F401,F403
from .numbers import *  # noqa: F401,F403
from .calendar import *  # noqa: F401,F403
