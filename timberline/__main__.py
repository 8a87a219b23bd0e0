import sys

from timberline.cli import main

sys.exit(main())
