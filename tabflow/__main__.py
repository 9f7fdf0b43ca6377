import sys

from tabflow.cli import main

sys.exit(main())
