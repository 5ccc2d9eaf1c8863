from lodestone.cli import main

raise SystemExit(main())
