import sys

from mosaiq.cli import main

sys.exit(main())
