"""``python -m rowscope``."""

import sys

from rowscope.cli import main

sys.exit(main())
