from weftline.plans.cli import main

raise SystemExit(main())
