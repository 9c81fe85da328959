from matrixlake.cli import main

raise SystemExit(main())
