import sys

from lipika.cli import main

sys.exit(main())
