import sys

from skinnyla.cli import main

sys.exit(main())
