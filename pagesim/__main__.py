from .plans.audit import main

main()
