"""spark-submit run.py --transcripts IN --out OUT [...]; see relaydesk/plans/run.py."""

from relaydesk.plans.run import main

if __name__ == "__main__":
    main()
